"""Messages of servers, templates and script checks, and sentences that speak of such things.

None was taken from the given tables. ``TUNED`` was looked at while the rules
of ``residue.py`` were written; ``HELD`` was written down before them and only
ever counted.
"""

TUNED = [
    "404 Not Found", "403 Forbidden", "页面不存在", "系统繁忙，请稍后再试", "您的浏览器不支持JavaScript", "Just a moment...",
    "Checking your browser before accessing the site", "Attention Required! | Cloudflare", "网络异常，请检查网络后重试", "数据库错误",
    "Access to this page has been denied", "An error occurred while processing your request", "Trang này không tồn tại",
    "Ce site nécessite JavaScript", "[INSERT TEXT HERE]", "请在此输入内容", "服务暂时不可用", "正在为您跳转，请稍等", "Lỗi kết nối cơ sở dữ liệu",
    "Halaman tidak ditemukan", "ページが見つかりません", "Please enable cookies to continue", "This page isn't working right now", "Whoops, looks like something went wrong.",
    "Error establishing a database connection", "The connection was reset", "内容正在审核中", "您的访问过快，请稍后再试", "Veuillez activer JavaScript", "502 Bad Gateway nginx",
]

HELD = [
    "500 Internal Server Error", "503 Service Temporarily Unavailable", "504 Gateway Time-out", "401 Unauthorized", "410 Gone", "429 Too Many Requests", "408 Request Timeout",
    "HTTP Error 404: page not found", "Error 1020: Access denied", "The server encountered an internal error and was unable to complete your request.",
    "The requested URL was not found on this server.", "Sorry, the page you are looking for does not exist.", "This page could not be found.", "Oops! That page can't be found.",
    "You don't have permission to access this resource.", "The service is unavailable.", "The server is temporarily unable to service your request due to maintenance downtime.",
    "Our site is currently down for maintenance. Please check back soon.", "We'll be back soon!", "Please turn JavaScript on and reload the page.",
    "You need to enable JavaScript to run this app.", "JavaScript is disabled in your browser.", "JavaScript is required to view this page", "This site requires cookies and JavaScript.",
    "Your browser is out of date. Please update your browser.", "Your browser is not supported", "Enable JavaScript and cookies to continue", "Verifying you are human. This may take a few seconds.",
    "DDoS protection by Cloudflare", "Please complete the security check to access the website", "Your session has timed out. Please log in again.", "Session expired, please sign in again",
    "Invalid request", "Bad request", "Request failed with status code 500", "Failed to load content. Tap to retry.", "Failed to fetch", "Network error, please try again later",
    "Unable to connect to the server", "Connection timed out", "Connection refused by host", "Server is busy, please try again later", "Server overloaded",
    "Unexpected error, please try again", "Something went wrong, try reloading the page", "An unknown error has occurred", "Loading chapter content, please wait a moment", "Content is loading...",
    "Fatal error: Uncaught exception", "Warning: mysql_connect(): Too many connections", "Could not connect to the database server", "Template not found", "Content unavailable", "This content has been deleted",
    "This link has expired", "Lorem ipsum dolor sit amet, consectetur adipiscing elit", "Your text goes here", "Insert content here", "Sample text", "Placeholder text", "Enter title here", "TODO: add text",
    "服务器内部错误", "服务器维护中，请稍后访问", "服务器响应超时", "网关错误", "无法访问此网站", "无法连接到服务器", "连接超时，请重试", "连接被重置", "数据库连接失败", "数据加载失败，请刷新页面",
    "页面加载失败", "页面加载中，请稍候……", "正在加载中", "内容加载中", "加载超时，点击重新加载", "您访问的页面不存在或已被删除", "对不起，您要找的页面不存在", "抱歉，该内容已被删除", "该章节已被屏蔽", "该链接已失效",
    "访问被拒绝", "您没有权限访问该页面", "权限不足，请登录后再试", "登录已过期，请重新登录", "登录超时", "请求错误", "请求参数错误", "请求超时，请稍后重试", "操作过于频繁，请稍后再试", "访问太频繁，请休息一下",
    "请输入验证码后继续访问", "请完成安全验证", "请开启浏览器的JavaScript功能", "请启用JavaScript后刷新本页", "当前浏览器不支持脚本，请更换浏览器", "您的浏览器版本过低，请升级浏览器", "系统错误", "系统异常，请联系管理员",
    "未知错误", "网络连接失败", "网络不给力，请稍后重试", "网站升级维护中", "网站正在维护，请稍后再来", "程序发生错误", "接口调用失败", "此处填写正文内容", "请在这里输入标题", "这是一段示例文字", "占位文本", "测试内容", "暂无内容",
    "章节内容为空", "内容获取失败，请重新加载",
    "Không thể kết nối đến máy chủ", "Máy chủ không phản hồi", "Hệ thống đang bảo trì, vui lòng quay lại sau", "Đã xảy ra lỗi, vui lòng thử lại", "Bạn không có quyền truy cập trang này", "Trang không tìm thấy",
    "Vui lòng bật JavaScript để tiếp tục", "Trình duyệt của bạn không hỗ trợ JavaScript", "Phiên đăng nhập đã hết hạn", "Đang tải, vui lòng chờ", "Nội dung không tồn tại", "Quá nhiều yêu cầu, hãy thử lại sau",
    "Page introuvable", "Erreur interne du serveur", "Accès refusé", "Une erreur est survenue, veuillez réessayer", "Votre navigateur n'est pas à jour", "Chargement en cours, veuillez patienter",
    "Terjadi kesalahan pada server", "Akses ditolak", "Silakan coba lagi nanti", "Aktifkan JavaScript di browser Anda", "Sedang memuat halaman",
    "サーバーエラーが発生しました", "アクセスが拒否されました", "JavaScriptを有効にしてください", "読み込み中です。しばらくお待ちください", "お使いのブラウザは対応していません", "ただいまメンテナンス中です",
]

#: Sentences of stories; they speak of messages, or are stock that recurs.
SPOKEN = [
    "他说系统维护的时候不能进入游戏。", "服务器繁忙，小明叹了口气，只好先去吃饭。", "“页面不存在”，屏幕上跳出这么一行字，她愣住了。", "手机提示网络异常，他把它扔到床上。", "她打开浏览器，输入了那个地址。",
    "电脑一直在加载，老板急得团团转。", "他盯着屏幕上的404，半天没有说话。", "数据库里没有这个人的名字。", "门口的保安说他没有权限进去。", "会议请求被拒绝了三次，经理终于死心。", "他把链接发给了她，什么也没说。",
    "小王写的脚本又出错了，同事们哈哈大笑。", "She stared at the words page not found and closed the lid.", "He said the server was down again, so they went home.", "The old gateway was closed, and nobody answered.",
    "“请稍等。”掌柜转身进了里屋。", "请稍候片刻，容我去通报老爷。", "权限二字，压得他喘不过气来。", "一夜无话。", "差役在当铺门口贴了告示。", "他重新载入了弹药，继续射击。", "系统提示：恭喜宿主获得新手礼包！",
    "叮当叮当叮当叮当。", "哈哈哈哈哈哈哈哈！", "咚，咚，咚。", "Không ai trả lời, hắn lặng lẽ quay về.", "Nàng thử lại lần nữa nhưng cánh cửa vẫn đóng.", "上一章", "返回目录", "下一页", "分享到微信", "本章完", "未完待续",
    "服务员说今天的鱼卖完了。", "维护世界和平的任务落到了他的肩上。", "他在网吧里等游戏更新，等到睡着了。", "敌人的线路已经暴露，请求支援！", "接口处漏了水，工人忙了一夜。",
]
